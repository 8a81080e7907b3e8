"""The flow view as one HTML page without outside resources."""

from __future__ import annotations

from html import escape

from .operators.exports import to_json

_PAGE = """<!doctype html>
<html><head><title>@TITLE@</title><meta charset=utf-8>
<style>
body{margin:0;font:14px system-ui,sans-serif;display:grid;grid-template-columns:20rem 1fr;height:100vh}
#list{overflow:auto;border-right:1px solid #ccc;padding:.5rem}#list div{cursor:pointer;padding:.1rem .3rem}
#list div:hover{background:#eef}#right{overflow:auto}#main{padding:1rem}svg{width:100%;max-height:60vh}line{stroke:#bbb}circle{fill:#58a;cursor:pointer}svg text{font-size:11px;text-anchor:middle;pointer-events:none}#rows tr{cursor:pointer}input{width:95%;margin-bottom:.5rem}table{border-collapse:collapse}td,th{padding:.15rem .6rem;text-align:left}
</style>
<body><div id="list"><input id="q" placeholder="Search files and symbols"><div id="hits"></div></div><div id="right"><svg style="position:absolute;width:0;height:0"><defs><marker id="tip" viewBox="0 0 8 8" refX=14 refY=4 markerWidth=5 markerHeight=5 orient=auto><path d="M0 0L8 4L0 8z"/></marker></defs></svg><svg id="flow" viewBox="0 0 1000 700"></svg><div id="main"></div></div>
<script type="application/json" id="data">@DATA@</script>
<script>
const D=JSON.parse(document.getElementById('data').textContent),E=s=>String(s).replace(/&/g,'&amp;').replace(/</g,'&lt;').replace(/>/g,'&gt;').replace(/"/g,'&quot;');
const all=[...D.level1.nodes.map(f=>({file:f.id,label:f.label,id:f.id})),...Object.entries(D.level2).flatMap(([f,x])=>x.nodes.map(n=>({id:n.node_id,label:n.name,file:f})))];
const more=(l,n)=>l.slice(0,n).map(E).join('<br>')+(l.length>n?`<br>… and ${l.length-n} more`:'');
function list(){const q=document.getElementById('q').value.toLowerCase();const has=s=>s.toLowerCase().indexOf(q)>=0,hits=all.filter(x=>has(x.label)||has(x.id)).slice(0,q?40:400);
 const box=document.getElementById('hits');box.innerHTML='';for(const h of hits){const d=document.createElement('div');d.textContent=h.label;d.title=h.id;d.onclick=()=>show(h.file);box.append(d)}}
const $=i=>document.getElementById(i);
function place(n,es){const p=Array.from({length:n},(_,i)=>[500+420*Math.cos(6.2832*i/n),350+300*Math.sin(6.2832*i/n)]);if(n>400)return p; // more stay on the ring
 const k=Math.sqrt(6e5/Math.max(1,n));for(let t=60;t>1;t*=.94){const d=p.map(()=>[0,0]);const push=(i,j,f)=>{const x=p[i][0]-p[j][0]||.1,y=p[i][1]-p[j][1]||.1,r=Math.hypot(x,y),g=f(r)/r;d[i][0]+=x*g;d[i][1]+=y*g;d[j][0]-=x*g;d[j][1]-=y*g};
  for(let i=0;i<n;i++)for(let j=0;j<i;j++)push(i,j,r=>k*k/r);for(const[a,b]of es)if(a!==b)push(a,b,r=>-r*r/k);
  for(let i=0;i<n;i++){const r=Math.hypot(...d[i])||1,m=Math.min(r,t)/r;p[i]=[Math.min(980,Math.max(20,p[i][0]+d[i][0]*m)),Math.min(680,Math.max(20,p[i][1]+d[i][1]*m))]}}return p}
function draw(el,ns,es,pick){const p=place(ns.length,es);el.innerHTML=es.map(([a,b,w])=>`<line x1=${p[a][0]} y1=${p[a][1]} x2=${p[b][0]} y2=${p[b][1]} stroke-width=${Math.min(6,1+Math.log2(w||1)/2)} marker-end="url(#tip)"><title>${E(ns[a].label)} → ${E(ns[b].label)}${w?' ('+w+')':''}</title></line>`).join('')
 +ns.map((n,i)=>`<g data-i=${i}><circle cx=${p[i][0]} cy=${p[i][1]} r=${n.r}><title>${E(n.id)}</title></circle><text x=${p[i][0]} y=${p[i][1]-n.r-2}>${ns.length<=80?E(n.label):''}</text></g>`).join('');el.querySelectorAll('g').forEach(g=>g.onclick=()=>pick(+g.dataset.i))}
const place1=new Map(D.level1.nodes.map((n,i)=>[n.id,i]));
function flow(){draw($('flow'),D.level1.nodes.map(n=>({id:n.id,label:n.label,r:n.radius})),D.level1.edges.filter(e=>place1.has(e.source)&&place1.has(e.target)).map(e=>[place1.get(e.source),place1.get(e.target),e.weight]),i=>show(D.level1.nodes[i].id))}
function symbol(f,i){const x=D.level2[f],s=x.nodes[i],by=x.edges.filter(e=>e[1]===i).map(e=>x.nodes[e[0]].name),to=x.edges.filter(e=>e[0]===i).map(e=>x.nodes[e[1]].name);
 $('symbol').innerHTML=`<h3>${E(s.kind)} ${E(s.name)}</h3><p>${E(s.node_id)} · line ${s.line}</p><table><tr><th>Called here by<th>Calls here</tr><tr><td>${more(by,20)}<td>${more(to,20)}</tr></table>`}
function show(f){const n=D.level1.nodes.find(x=>x.id===f),x=D.level2[f]??{edges:[],nodes:[]};
 const from=D.level1.edges.filter(e=>e.target===f).map(e=>`${e.source} (${e.weight})`),to=D.level1.edges.filter(e=>e.source===f).map(e=>`${e.target} (${e.weight})`);
 $('main').innerHTML=`<h2>${E(f)}</h2><p>${E(n?n.language:'')} · ${n?n.symbol_count:0} symbols · called by ${n?n.in_degree:0} files · calls ${n?n.out_degree:0} files</p><table><tr><th>Called by<th>Calls</tr><tr><td>${more(from,30)}<td>${more(to,30)}</tr></table><div id=symbol></div><svg id=inside viewBox="0 0 1000 700"></svg><h3>Symbols</h3><table id=rows><tr><th>Line<th>Kind<th>Name</tr>${x.nodes.map(s=>`<tr><td>${s.line}<td>${E(s.kind)}<td>${E(s.name)}</tr>`).join('')}</table>`;
 draw($('inside'),x.nodes.map(s=>({id:s.node_id,label:s.name,r:6})),x.edges,i=>symbol(f,i));[...$('rows').rows].slice(1).forEach((r,i)=>r.onclick=()=>symbol(f,i))}
document.getElementById('q').oninput=list;list();flow();if(D.level1.nodes.length)show(D.level1.nodes[0].id);
</script></body></html>
"""


def render(flow: dict, title: str) -> str:
    return _PAGE.replace("@TITLE@", escape(title)).replace("@DATA@", to_json(flow))
